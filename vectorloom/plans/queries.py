"""One query an operator, over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.evaluate import forced
from vectorloom.functions import vectors as V
from vectorloom.functions.folders import remove, shared_dir
from vectorloom.functions.text import file_stem, file_suffix, raw_text_id
from vectorloom.operators import alignment, chunking, ingest, rate_limits, retrieval
from vectorloom.operators.ingest import Pipeline
from vectorloom.operators.providers import HashProvider, LetterProvider, LinearProvider, NoProviderAvailableError, ScriptedProvider
from vectorloom.sources import anchors as anchor_source
from vectorloom.sources.documents import from_html
from vectorloom.sources.sinks import document_json
from vectorloom.streaming.cooldowns import stream_cooldowns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("vector"))


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# -- sources and scalar functions -------------------------------------------------------


@query("SELECT doc_id, 'text-' || substr(sha256(text), 1, 12) AS text_id FROM documents")
def doc_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", raw_text_id(F.col("text")).alias("text_id"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END AS stem,
  lower(regexp_extract(name, '[^/](\.[^./]+)$', 1)) AS suffix FROM p
""")
def path_parts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", file_stem(F.col("url")).alias("stem"), file_suffix(F.col("url")).alias("suffix"))


@query(r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[!/a-zA-Z][^>]*>', chr(1), 'g'), chr(1)) AS nodes FROM pages)
SELECT page_id AS doc_id, regexp_replace(replace(replace(replace(array_to_string(list_filter(nodes, lambda x: x <> ''), chr(10)),
  '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM p
""")
def html_text(spark, sf_dir):
    return from_html(_table(spark, sf_dir, "pages"), "page_id")


_VERSION_SQL = "SELECT 'base-' || substr(sha256(string_agg(text, chr(9247) ORDER BY item_id)), 1, 12) AS corpus_version FROM benchmark"


def _anchors(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("anchor_idx"), "text")


@query(_VERSION_SQL)
def corpus_version(spark, sf_dir):
    return anchor_source.corpus_version(_anchors(spark, sf_dir))


@query(r"""
SELECT 'base-' || substr(sha256(string_agg(text, chr(9247) ORDER BY item_id) FILTER (WHERE item_id % 2 = 0)), 1, 12)
  || '_ext-' || substr(sha256(string_agg(text, chr(9247) ORDER BY item_id) FILTER (WHERE item_id % 2 = 1)), 1, 12) AS corpus_version FROM benchmark
""")
def corpus_version_extended(spark, sf_dir):
    whole = _anchors(spark, sf_dir)
    return anchor_source.corpus_version(whole.where("anchor_idx % 2 = 0"), whole.where("anchor_idx % 2 = 1"))


@query(r"""
WITH e AS (SELECT item_id, text, item_id % 2 AS odd, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id) - 1 AS i FROM benchmark)
SELECT CASE WHEN odd = 0 THEN i ELSE i + (SELECT count(*) FROM e WHERE odd = 0) END AS anchor_idx, text FROM e
""")
def anchor_corpus(spark, sf_dir):
    ranked = _anchors(spark, sf_dir).withColumn("odd", F.col("anchor_idx") % 2)
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("odd").orderBy("anchor_idx")) - 1)
    part = lambda k: ranked.where(F.col("odd") == k).select(F.col("i").alias("anchor_idx"), "text")
    return anchor_source.with_extras(part(0), part(1)).withColumn("anchor_idx", F.col("anchor_idx").cast("long"))


# -- chunkers ---------------------------------------------------------------------------

_FIXED = """
  SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1
    ELSE CAST(ceil((length(text) - 1000) / 900.0) AS INT) + 1 END AS k, lang FROM documents
"""
_FIXED_ROWS = f"""
  SELECT doc_id, lang, i AS chunk_idx, doc_id || ':' || i AS chunk_id, substr(text, i * 900 + 1, 1000) AS text,
    i * 900 AS start_char, least(i * 900 + 1000, n) AS end_char
  FROM (SELECT *, unnest(range(0, k)) AS i FROM ({_FIXED}))
"""


@query(f"SELECT doc_id, chunk_idx, chunk_id, text, start_char, end_char FROM ({_FIXED_ROWS})")
def chunk_fixed(spark, sf_dir):
    return chunking.FixedChunker().chunk(_docs(spark, sf_dir))


@query(f"SELECT lang, count(*) AS n_chunks, sum(end_char - start_char) AS n_chars, max(chunk_idx) AS last_idx FROM ({_FIXED_ROWS}) GROUP BY lang")
def chunk_fixed_stats(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    chunks = chunking.FixedChunker().chunk(docs).drop("text").join(docs.select("doc_id", "lang"), "doc_id")
    return chunks.groupBy("lang").agg(
        F.count("*").alias("n_chunks"), F.sum(F.col("end_char") - F.col("start_char")).cast("long").alias("n_chars"), F.max("chunk_idx").alias("last_idx")
    )


@query(r"""
WITH s AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM documents
), f AS (
  SELECT doc_id, list_reduce(list_transform(ss, lambda x: [x]), lambda a, x:
    CASE WHEN length(a[-1]) + length(x[1]) > 500 THEN a || x ELSE a[:-2] || [a[-1] || ' ' || x[1]] END) AS chunks FROM s WHERE len(ss) > 0
)
SELECT doc_id, i - 1 AS chunk_idx, chunks[i] AS text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM f)
""")
def chunk_semantic(spark, sf_dir):
    return chunking.SemanticChunker().chunk(_docs(spark, sf_dir)).select("doc_id", "chunk_idx", "text")


@query(r"""
WITH t AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS parts FROM documents
), o AS (
  SELECT doc_id, i, parts[i] AS h, sum(length(parts[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t)
), s AS (
  SELECT doc_id, list({'h': h, 's': CAST(e - length(h) AS BIGINT), 'e': CAST(e AS BIGINT)} ORDER BY i) AS ss FROM o WHERE i % 2 = 1 AND trim(h) <> '' GROUP BY doc_id
), f AS (
  SELECT doc_id, list_reduce(list_transform(ss, lambda x: [x]), lambda a, x:
    CASE WHEN length(a[-1].h) + length(x[1].h) > 500 THEN a || x
    ELSE a[:-2] || [{'h': a[-1].h || ' ' || x[1].h, 's': CASE WHEN a[-1].s = 0 THEN x[1].s ELSE a[-1].s END, 'e': x[1].e}] END) AS c FROM s
)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_idx, doc_id || ':' || (i - 1) AS chunk_id, c[i].s AS start_char, CASE WHEN i < len(c) THEN c[i + 1].s ELSE c[i].e END AS end_char
FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM f)
""")
def chunk_semantic_offsets(spark, sf_dir):
    return chunking.SemanticChunker().chunk(_docs(spark, sf_dir)).drop("text")


# Each level takes the pieces that are too long, splits them, and packs what it gets; '' stands for nothing held.
_PACK = """list_filter(list_reduce(list_prepend([''], list_transform(string_split(x, {sep}), lambda y: [y])), lambda a, p:
    CASE WHEN length(CASE WHEN a[-1] = '' THEN p[1] ELSE a[-1] || {sep} || p[1] END) <= 1000 THEN a[:-2] || [CASE WHEN a[-1] = '' THEN p[1] ELSE a[-1] || {sep} || p[1] END]
    ELSE list_concat(CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END, CASE WHEN length(p[1]) > 1000 THEN [p[1], ''] ELSE [p[1]] END) END), lambda y: y <> '')"""
_LEVELS = "SELECT doc_id, text, [text] AS ps FROM documents"
for _sep in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"):
    _LEVELS = f"SELECT doc_id, text, flatten(list_transform(ps, lambda x: CASE WHEN length(x) <= 1000 THEN [x] ELSE {_PACK.format(sep='(' + _sep + ')')} END)) AS ps FROM ({_LEVELS})"
_RECURSIVE = f"""
  SELECT doc_id, CAST(i - 1 AS INT) AS chunk_idx, doc_id || ':' || (i - 1) AS chunk_id, c[i + 1].t AS text, c[i + 1].e - length(c[i + 1].t) AS start_char, c[i + 1].e AS end_char
  FROM (SELECT doc_id, c, unnest(range(1, len(c))) AS i FROM (
    SELECT doc_id, list_reduce(list_prepend([{{'t': '', 'e': 0::BIGINT}}], list_transform(ps, lambda x: [{{'t': x, 'e': 0::BIGINT}}])), lambda a, x:
      a || [{{'t': x[1].t, 'e': a[-1].e + greatest(strpos(substr(text, a[-1].e + 1), x[1].t) - 1, 0) + length(x[1].t)}}]) AS c FROM ({_LEVELS})))
"""


@query(f"SELECT doc_id, chunk_idx, chunk_id, text, start_char, end_char FROM ({_RECURSIVE})")
def chunk_recursive(spark, sf_dir):
    return chunking.RecursiveChunker().chunk(_docs(spark, sf_dir))


@query(r"""
SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS n_chars FROM (
  SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)) AS line FROM documents) GROUP BY doc_id
""")
def chunk_custom(spark, sf_dir):
    """A strategy of the user's own: lines."""

    def split(text: str):
        at = 0
        for line in text.split("\n"):
            if line:
                yield line, at, at + len(line)
            at += len(line) + 1

    chunks = chunking.CustomChunker(split).chunk(_docs(spark, sf_dir))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


# -- embeddings and vector functions ----------------------------------------------------

_LETTERS = " || ',' || ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))" for c in "abcdefghijklmnopqrstuvwxyz")


@query(f"SELECT chunk_id, {_LETTERS} AS letters FROM ({_FIXED_ROWS})")
def embed_letters(spark, sf_dir):
    """The flagship path: chunk, embed, project."""
    chunks = chunking.FixedChunker().chunk(_docs(spark, sf_dir))
    counts = F.transform(V.letter_counts(F.col("text")), lambda x: x.cast("int").cast("string"))
    return chunks.select("chunk_id", F.array_join(counts, ",").alias("letters"))


@query(r"""
WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT label, i - 1 AS pos, CAST(round(avg(v[i]) * 10000) AS BIGINT) AS mean_e4 FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i
""")
def mean_pool(spark, sf_dir):
    """Vectors by label, averaged by position."""
    pooled = V.mean_pool_by(_table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return pooled.select("label", "pos", F.round(F.col("x") * 10000).cast("long").alias("mean_e4"))


@query(r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(round(sqrt(list_sum(list_transform(v, lambda x: x * x))) * 1000) AS BIGINT) AS norm_e3,
  CAST(round(list_sum(list_transform(v[1:32], lambda x: x * x)) * 10000) AS BIGINT) AS half_dot_e4,
  len(v || list_transform(range(0, 80 - len(v)), lambda x: 0::DOUBLE)) AS padded, len(v[1:32]) AS cut
FROM e
""")
def vector_functions(spark, sf_dir):
    v = V.as_double(F.col("embedding"))
    cut = V.truncate(v, 32)
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(V.norm(v) * 1000).cast("long").alias("norm_e3"),
        F.round(V.dot(V.pad_right(cut, 64), v) * 10000).cast("long").alias("half_dot_e4"),
        F.size(V.pad_right(v, 80)).alias("padded"),
        F.size(cut).alias("cut"),
    )


# -- retrieval --------------------------------------------------------------------------

_TOP_SQL = """
  SELECT q, d, sim, rank FROM (
    SELECT a.vec_id AS q, b.vec_id AS d, round(list_cosine_similarity({a}, {b}), 6) AS sim,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity({a}, {b}), 6) DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b)
"""
_DOUBLE = "list_transform({t}.embedding, lambda x: x::DOUBLE)"
_CUT = "(list_transform({t}.embedding[1:32], lambda x: x::DOUBLE) || list_transform(range(0, 32), lambda x: 0::DOUBLE))"
_PLAIN = _TOP_SQL.format(a=_DOUBLE.format(t="a"), b=_DOUBLE.format(t="b"))
_HALF = _TOP_SQL.format(a=_CUT.format(t="a"), b=_DOUBLE.format(t="b"))


def _halved(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", V.pad_right(V.truncate(F.col("vector"), 32), 64).alias("vector"))


@query(f"SELECT q, d, rank FROM ({_PLAIN}) WHERE rank <= 5")
def topk_retrieval(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return retrieval.top_k(vectors, vectors, 5, digits=6).select("q", "d", "rank")


@query(f"SELECT round(avg(1.0 / rank), 6) AS mrr FROM ({_HALF}) WHERE q = d")
def mrr(spark, sf_dir):
    ranks = retrieval.own_rank(_halved(spark, sf_dir), _vectors(spark, sf_dir), digits=6)
    return retrieval.mean_reciprocal_rank(ranks).select(F.round("mrr", 6).alias("mrr"))


@query(f"""
WITH x AS (SELECT q, d FROM ({_PLAIN}) WHERE rank <= 5), y AS (SELECT q, d FROM ({_HALF}) WHERE rank <= 5)
SELECT round((SELECT count(*) FROM x JOIN y USING (q, d)) / (5.0 * (SELECT count(*) FROM embeddings)), 6) AS overlap
""")
def overlap(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    a, b = retrieval.top_k(vectors, vectors, 5, 6), retrieval.top_k(_halved(spark, sf_dir), vectors, 5, 6)
    return retrieval.top_k_overlap(a, b, 5).select(F.round("overlap", 6).alias("overlap"))


@query(f"""
SELECT round((SELECT avg(1.0 / rank) FROM ({_HALF}) WHERE q = d) / (SELECT avg(1.0 / rank) FROM ({_PLAIN}) WHERE q = d), 6) AS retention
""")
def retention(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    of = lambda q, name: retrieval.mean_reciprocal_rank(retrieval.own_rank(q, vectors, 6)).select(F.col("mrr").alias(name))
    both = of(_halved(spark, sf_dir), "aligned").crossJoin(of(vectors, "baseline"))
    return both.select(F.round(retrieval.retention(F.col("aligned"), F.col("baseline")), 6).alias("retention"))


# -- alignment --------------------------------------------------------------------------


def _signed_permutation(d: int) -> np.ndarray:
    order = np.random.default_rng(11).permutation(d)
    return 2.5 * np.eye(d)[order] * np.where(np.arange(d) % 2, -1.0, 1.0)[:, None]


def _space(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    return alignment.apply_transform(vectors, "vector", alignment.Transform(matrix, 1.0))


def _paired(vectors: DataFrame) -> DataFrame:
    """Every vector is an anchor: the image under `vector`, the original under `target`."""
    return vectors.withColumn("target", F.col("vector"))


@query(r"""
SELECT vec_id, i - 1 AS pos, CAST(round(list_transform(embedding, lambda x: x::DOUBLE)[i] * 10000) AS BIGINT) AS value_e4
FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
""")
def align_same_dim(spark, sf_dir):
    """Vectors of a scaled, turned space come back as the originals: in the table's own precision, so that values
    halfway between two integers are rounded as the originals are."""
    kind = _table(spark, sf_dir, "embeddings").schema["embedding"].dataType.elementType
    there = _space(_paired(_vectors(spark, sf_dir)), _signed_permutation(64))
    transform, _ = alignment.fit_alignment_table(there, "vector", "target", "id")
    back = alignment.apply_transform(there, "vector", transform)
    values = back.select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("pos", "x"))
    return values.select("vec_id", "pos", F.round(F.col("x").cast(kind).cast("double") * 10000).cast("long").alias("value_e4"))


def _diagnostics(spark, d: alignment.Diagnostics) -> DataFrame:
    row = (d.anchor_corpus_size, d.reduced_dimension, round(d.scale_factor, 6), round(abs(d.mean_cosine_alignment_error), 6), d.pca_explained_variance, d.pca_fallback_used, d.rank)
    return spark.createDataFrame([row], "anchors long, reduced_dimension int, scale double, error double, explained double, fallback string, rank int")


@query("SELECT count(*) AS anchors, 0.4::DOUBLE AS scale, 0.0::DOUBLE AS error, 1.0::DOUBLE AS confidence, max(len(embedding)) AS rank FROM embeddings")
def align_diagnostics(spark, sf_dir):
    there = _space(_paired(_vectors(spark, sf_dir)), _signed_permutation(64))
    _, found = alignment.fit_alignment_table(there, "vector", "target", "id")
    return _diagnostics(spark, found).select("anchors", "scale", "error", alignment.confidence(F.col("error")).alias("confidence"), "rank")


@query("SELECT count(*) AS anchors, max(len(embedding)) AS reduced_dimension, 'padded_zeros' AS fallback, max(len(embedding[1:32])) AS rank FROM embeddings")
def align_padded(spark, sf_dir):
    narrow = _paired(_vectors(spark, sf_dir)).withColumn("vector", V.truncate(F.col("vector"), 32))
    _, found = alignment.fit_alignment_table(narrow, "vector", "target", "id")
    return _diagnostics(spark, found).select("anchors", "reduced_dimension", "fallback", "rank")


@query("SELECT count(*) AS anchors, max(len(embedding[1:16])) AS reduced_dimension, TRUE AS accepted FROM embeddings")
def align_pca(spark, sf_dir):
    """A wider space of low rank is reduced, and its vectors come out in the narrower one."""
    narrow = _vectors(spark, sf_dir).withColumn("vector", V.truncate(F.col("vector"), 16))
    wide = _space(_paired(narrow), np.linalg.qr(np.random.default_rng(3).normal(size=(48, 16)))[0].T)
    _, found = alignment.fit_alignment_table(wide, "vector", "target", "id")
    return _diagnostics(spark, found).select("anchors", "reduced_dimension", (F.col("fallback").isNull() & (F.col("error") < 0.1)).alias("accepted"))


@query(r"""
SELECT CAST(round(sum(a[1] * a[1]) * 1000) AS BIGINT) AS first_e3, CAST(round(sum(list_sum(list_transform(a, lambda x: x * x))) * 1000) AS BIGINT) AS power_e3
FROM (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)
""")
def cross_gram(spark, sf_dir):
    gram, power = alignment.cross_gram(_vectors(spark, sf_dir), "vector", "vector")
    return spark.createDataFrame([(int(round(gram[0, 0] * 1000)), int(round(power * 1000)))], "first_e3 long, power_e3 long")


# -- rate limits and routing ------------------------------------------------------------

# Response bodies of the classification's truth table.
BODIES = (
    '{"error":{"message":"Quota exceeded: PER_DAY requests"}}',
    '{"error":{"message":"slow down","details":[{"violations":[{"quotaId":"GenerateRequestsPerMinutePerProject"}]}]}}',
    '{"error":{"message":"daily and per_minute"}}',
    "please retry in 47.5s, this is no JSON",
    '{"error":{"message":"please retry in 12.25s."}}',
    '{"message":"You are using a Trial key"}',
    '{"estimated_time":12.5}',
    "{}",
    '{"error":{"message":"free_tier limit"}}',
)
_BODY_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BODIES)) + " END"


@query(rf"""
WITH r AS (
  SELECT event_id, ['google', 'cohere', 'voyage', 'huggingface'][(event_id % 4 + 1)::INT] AS provider, CASE WHEN event_id % 5 = 0 THEN 503 ELSE 429 END AS status,
    CASE event_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '30' WHEN 2 THEN '900' WHEN 3 THEN 'soon' END AS header, {_BODY_SQL} AS body FROM events
), p AS (
  SELECT *, try_cast(header AS DOUBLE) AS h, try_cast(regexp_extract(body, 'retry in (\d+(?:\.\d+)?)s', 1) AS DOUBLE) AS b,
    lower(coalesce(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.error.message') END, '') || ' ' ||
      coalesce(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.error.details[0].violations[0].quotaId') END, '')) AS g,
    lower(coalesce(CASE WHEN json_valid(body) THEN json_extract_string(body, '$.message') END, '')) AS m,
    CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.estimated_time') AS DOUBLE) END AS est FROM r
)
SELECT event_id, provider, status,
  CASE WHEN status = 503 THEN CASE WHEN provider = 'huggingface' THEN 'short_cooldown' END
    WHEN provider = 'google' THEN CASE WHEN NOT json_valid(body) THEN 'unknown' WHEN regexp_matches(g, 'perday|per_day|daily') THEN 'quota_exhausted'
      WHEN regexp_matches(g, 'perminute|per_minute|rpm') OR coalesce(h, b) <= 300 THEN 'short_cooldown' ELSE 'unknown' END
    WHEN provider = 'cohere' THEN CASE WHEN regexp_matches(m, 'trial key|monthly limit|monthly quota') THEN 'quota_exhausted' WHEN h IS NOT NULL THEN 'short_cooldown' ELSE 'unknown' END
    WHEN provider = 'voyage' THEN 'short_cooldown' ELSE CASE WHEN h <> 0 THEN 'short_cooldown' ELSE 'unknown' END END AS kind,
  CASE WHEN status = 503 THEN CASE WHEN provider = 'huggingface' THEN coalesce(nullif(est, 0), 20.0) END WHEN provider = 'google' THEN coalesce(h, b) ELSE h END AS retry_after
FROM p
""")
def rate_limit_classify(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (i % by + 1).cast("int"))
    rows = _events(spark, sf_dir).select(
        "event_id",
        pick(("google", "cohere", "voyage", "huggingface"), 4).alias("provider"),
        F.when(i % 5 == 0, 503).otherwise(429).alias("status"),
        pick(("0", "30", "900", "soon", None, None, None), 7).alias("header"),
        pick(BODIES, 9).alias("body"),
    )
    judged = rows.withColumn("c", rate_limits.classify(F.col("provider"), F.col("status"), F.col("header"), F.col("body")))
    return judged.select("event_id", "provider", "status", F.col("c.kind").alias("kind"), F.col("c.retry_after").alias("retry_after"))


@query("SELECT event_id, round((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) / 1e6, 3) AS seconds FROM events")
def seconds_to_midnight(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.round(rate_limits.seconds_to_midnight(F.col("ts")), 3).alias("seconds"))


@query(r"""
SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN greatest(0, value) WHEN event_id % 4 = 1 THEN 60
  WHEN event_id % 4 = 2 THEN (epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) / 1e6 ELSE 300 END, 3) AS seconds FROM events
""")
def cooldown_duration(spark, sf_dir):
    i = F.col("event_id") % 4
    kind = F.when(i == 1, rate_limits.SHORT).when(i == 2, rate_limits.QUOTA).otherwise(rate_limits.UNKNOWN)
    seconds = rate_limits.cooldown_seconds(kind, F.when(i == 0, F.col("value")), F.col("ts"))
    return _events(spark, sf_dir).select("event_id", F.round(seconds, 3).alias("seconds"))


@query(r"""
WITH w AS (SELECT event_id, ts, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events)
SELECT event_id, coalesce(epoch_us(l), -1) AS limited_us, coalesce(l + INTERVAL 6 HOUR > ts, FALSE) AS blocked FROM w
""")
def cooldown_asof(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("provider"), "ts", F.col("event_id").alias("seq"), "event_type")
    marked = rate_limits.asof_cooldown(events, F.col("event_type") == "error", 6 * 3600.0)
    return marked.select("event_id", F.coalesce(F.unix_micros("limited_at"), F.lit(-1)).alias("limited_us"), "blocked")


def _limits(spark, sf_dir):
    events = _events(spark, sf_dir).where("event_type = 'error'")
    limits = events.select(
        (F.col("user_id") % 8).cast("string").alias("provider"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit(rate_limits.QUOTA).alias("kind"), F.lit("limit").alias("reason")
    )
    now = _events(spark, sf_dir).agg(F.max("ts").alias("now"))
    return limits.withColumn("available_at", rate_limits.available_at(F.col("at"), F.lit(7200.0))), now


def _status(spark, sf_dir):
    limits, now = _limits(spark, sf_dir)
    providers = spark.range(10).select(F.col("id").cast("string").alias("provider"), F.col("id").cast("int").alias("priority")).crossJoin(F.broadcast(now))
    return rate_limits.router_status(providers, F.broadcast(rate_limits.latest_cooldowns(limits)), F.col("now"))


_STATUS_SQL = """
WITH n AS (SELECT max(ts) AS now FROM events), l AS (
  SELECT user_id % 8 AS p, arg_max(ts, (ts, event_id)) + INTERVAL 2 HOUR AS until FROM events WHERE event_type = 'error' GROUP BY 1
), s AS (SELECT i AS p, now, until FROM (SELECT unnest(range(0, 10)) AS i) LEFT JOIN l ON l.p = i, n)
"""


@query(_STATUS_SQL + """
SELECT CAST(p AS VARCHAR) AS provider, CAST(p AS INT) AS priority, coalesce(until <= now, TRUE) AS available,
  CASE WHEN until > now THEN round((epoch_us(until) - epoch_us(now)) / 1e6, 1) END AS seconds_remaining,
  CASE WHEN until > now THEN 'quota_exhausted' END AS kind, CASE WHEN until > now THEN 'limit' END AS reason FROM s
""")
def router_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query(_STATUS_SQL + "SELECT CAST(min(p) AS VARCHAR) AS provider FROM s WHERE coalesce(until <= now, TRUE) AND p NOT IN (0, 1)")
def pick_provider(spark, sf_dir):
    return rate_limits.pick_provider(_status(spark, sf_dir), excluded=("0", "1"))


@query(r"""
WITH w AS (SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM events)
SELECT event_id, CAST(user_id AS VARCHAR) AS provider, coalesce(l + INTERVAL 6 HOUR > ts, FALSE) AS blocked FROM w
""")
def stream_cooldown(spark, sf_dir):
    """The as-of cooldown as a stream with keyed state, run to its end over the events."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = source.select(
        F.col("user_id").cast("string").alias("provider"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_limit")
    )
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove(spark, out, at_exit=True)
    flow = stream_cooldowns(events, 6 * 3600.0).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows")
    flow.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "provider", "blocked")


# -- ingestion --------------------------------------------------------------------------


def _fallback(spark, sf_dir) -> DataFrame:
    """Chunks of odd length are refused by the first provider and embedded by the second."""
    first = ScriptedProvider(LetterProvider("primary"), lambda text: (rate_limits.SHORT, 30.0) if len(text) % 2 else None)
    pipeline = Pipeline(spark, [first, LetterProvider("backup")], "fixed", chunk_kwargs={"chunk_size": 2000})
    return pipeline.embed(pipeline.chunker.chunk(_docs(spark, sf_dir)))


_FALLBACK_SQL = """
WITH c AS (SELECT doc_id, i, least(i * 1900 + 2000, n) - i * 1900 AS len FROM (
  SELECT doc_id, length(text) AS n, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 2000) / 1900.0) AS INT) + 1 END)) AS i FROM documents)),
p AS (SELECT doc_id, i, CASE WHEN len % 2 = 0 THEN 'primary' ELSE 'backup' END AS provider FROM c),
k AS (SELECT doc_id, CASE WHEN bool_or(provider = 'primary') THEN 'primary' ELSE 'backup' END AS canonical_provider FROM p GROUP BY doc_id)
"""


@query(_FALLBACK_SQL + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, canonical_provider, 'letters-26' AS canonical_model FROM k")
def fallback_canonical(spark, sf_dir):
    return Pipeline.canonical(_fallback(spark, sf_dir))


@query(_FALLBACK_SQL + "SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (WHERE provider <> canonical_provider) AS provider_switches FROM p JOIN k USING (doc_id) GROUP BY doc_id")
def provider_switches(spark, sf_dir):
    embedded = _fallback(spark, sf_dir)
    return ingest.provider_switches(embedded.join(Pipeline.canonical(embedded), "doc_id"))


_BY_LENGTH = """
WITH p AS (SELECT *, {provider} AS provider FROM ({chunks})),
k AS (SELECT doc_id, {canonical} AS canonical_provider FROM p GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_idx, chunk_id, provider, CASE WHEN provider <> canonical_provider THEN canonical_provider END AS aligned_to,
  canonical_provider, {more} FROM p JOIN k USING (doc_id)
"""


@query(_BY_LENGTH.format(
    chunks=_RECURSIVE, provider="CASE WHEN length(text) % 3 = 0 AND text NOT IN (SELECT text FROM benchmark) THEN 'backup' ELSE 'primary' END",
    canonical="max(provider)", more="1.0::DOUBLE AS alignment_confidence, 16 AS dimension",
))
def ingest_aligned(spark, sf_dir):
    """The whole path on all documents: chunk, fall back, align into each document's canonical space."""
    base = HashProvider("primary", dimension=16)
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(16, 16)))[0]
    known = {r["text"] for r in _anchors(spark, sf_dir).collect()}
    first = ScriptedProvider(base, lambda text: (rate_limits.SHORT, 30.0) if len(text) % 3 == 0 and text not in known else None)
    pipeline = Pipeline(spark, [first, LinearProvider(base, 2.0 * turn, "backup")], "recursive", anchors=_anchors(spark, sf_dir))
    found = pipeline.ingest(_docs(spark, sf_dir)).chunks
    return found.select("doc_id", "chunk_idx", "chunk_id", "provider", "aligned_to", "canonical_provider", F.round("alignment_confidence", 6).alias("alignment_confidence"), F.size("vector").alias("dimension"))


@query(_BY_LENGTH.format(
    chunks=_FIXED_ROWS, provider="CASE WHEN length(text) % 3 = 1 THEN 'backup' ELSE 'primary' END",
    canonical="CASE WHEN bool_or(length(text) % 3 = 0) THEN 'primary' WHEN bool_or(length(text) % 3 = 1) THEN 'backup' ELSE 'primary' END",
    more="length(text) % 3 <> 2 AS is_resumed",
))
def ingest_resumed(spark, sf_dir):
    """A run that ends without a provider left, and the one after it, which asks for what was not answered alone."""
    base = HashProvider("primary", dimension=16)
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(16, 16)))[0]
    folder = f"{shared_dir(spark)}/resumed-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)

    def run(*answered):
        known = {r["text"] for r in _anchors(spark, sf_dir).collect()}
        refuse = lambda lengths: lambda text: None if len(text) % 3 in lengths or text in known else (rate_limits.SHORT, 30.0)
        providers = [ScriptedProvider(p, refuse(lengths)) for p, lengths in zip((base, LinearProvider(base, 2.0 * turn, "backup")), answered)]
        return Pipeline(spark, providers, "fixed", anchors=_anchors(spark, sf_dir), checkpoint_dir=folder).ingest(_docs(spark, sf_dir))

    try:
        run((0,), (1,))
    except NoProviderAvailableError:
        pass
    found = run((0, 1, 2), ()).chunks
    return found.select("doc_id", "chunk_idx", "chunk_id", "provider", "aligned_to", "canonical_provider", "is_resumed")


_CKPT = f"SELECT *, (doc_id + chunk_idx) % 3 = 0 AS saved FROM ({_FIXED_ROWS})"


@query(f"SELECT chunk_id FROM ({_CKPT}) WHERE NOT saved")
def resume_remaining(spark, sf_dir):
    chunks = chunking.FixedChunker().chunk(_docs(spark, sf_dir))
    saved = chunks.where((F.col("doc_id") + F.col("chunk_idx")) % 3 == 0).select("chunk_id")
    return ingest.remaining(chunks.select("chunk_id"), saved, ["chunk_id"])


@query(f"SELECT chunk_id, 'primary' AS provider FROM ({_CKPT}) WHERE saved")
def resume_restored(spark, sf_dir):
    chunks = chunking.FixedChunker().chunk(_docs(spark, sf_dir))
    saved = chunks.where((F.col("doc_id") + F.col("chunk_idx")) % 3 == 0).select("chunk_id", F.lit("primary").alias("provider"))
    return ingest.restored(chunks, saved, ["chunk_id"])


@query(f"SELECT chunk_id, chunk_idx // 5 AS batch, ['a', 'b', 'c'][chunk_idx % 3 + 1] AS provider FROM ({_FIXED_ROWS})")
def batches_round_robin(spark, sf_dir):
    """Batch numbers by concurrency, and the evaluator's forced provider."""
    chunks = chunking.FixedChunker().chunk(_docs(spark, sf_dir))
    provider = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), forced(F.col("chunk_idx"), 3) + 1)
    return chunks.select("chunk_id", ingest.batch_number(F.col("chunk_idx")).alias("batch"), provider.alias("provider"))


@query(f"SELECT doc_id, count(*) AS n_chunks, max(end_char) AS last_end FROM ({_FIXED_ROWS}) GROUP BY doc_id")
def json_sink(spark, sf_dir):
    """The document objects of the JSON sink, summed up."""
    chunks = chunking.FixedChunker().chunk(_docs(spark, sf_dir)).withColumns(
        {"vector": V.letter_counts(F.col("text")), "provider": F.lit("letters"), "model": F.lit("letters-26"), "aligned_to": F.lit(None).cast("string"), "alignment_confidence": F.lit(1.0), "canonical_provider": F.lit("letters")}
    )
    docs = _docs(spark, sf_dir).select("doc_id")
    out = document_json(chunks, docs)
    return out.where(F.size("chunks") > 0).select(
        "doc_id", F.size("chunks").cast("long").alias("n_chunks"), ((F.size("chunks") - 1) * 900 + F.length(F.element_at("chunks", -1)["text"])).alias("last_end")
    )
