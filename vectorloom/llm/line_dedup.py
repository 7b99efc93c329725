"""Line dedup: explode normalised lines, hash them, count distinct documents a hash, drop
lines over the threshold, reassemble by position.

Only keys long enough to be judged are exploded, as 16-byte digests with their positions; what is joined
back is the positions of a text's dropped lines. The text of a document moves once, in the final
reassembly, and not at all where that table is small enough for a broadcast that Spark checks by size itself.
Every step costs time in proportion to the lines, however many a text has.

Defined cases: null or empty text is one empty line; a key held by several rows of one
doc_id counts one document; the largest doc_id holding a key keeps all its lines with it
(null doc_ids never win, and together count as no document); short keys are never
dropped; a text of any length or number of lines is judged within its own row; extra columns
are carried along, working columns start with `__line_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, let, materialise, read

MIN_CHARS = 40
MIN_DOCS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digests(text: Column, min_chars: int) -> Column:
    """For each line its key's digest, or null where the key is too short to be judged."""
    return F.transform(
        F.transform(_lines(text), lambda x: F.btrim(x, F.lit(SPACES))),
        lambda x: F.when(F.length(x) >= min_chars, F.unhex(F.md5(ascii_lower(x)))),
    )


def _text_name(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def judged_lines(docs: DataFrame, named: bool = False, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, `__line_at` (0, 1, ...) and `__line_key` of every line that is long enough, and if `named` the text's
    digest `__line_text`. The digest is made inside the generated array, else it would be made for every line."""
    keys = _digests(F.col("text"), min_chars)
    if not named:
        rows = docs.select("doc_id", F.posexplode(keys).alias("__line_at", "__line_key"))
        return rows.where("__line_key is not null")
    both = let(_text_name(F.col("text")), lambda name: F.transform(keys, lambda k: F.when(k.isNotNull(), F.struct(name.alias("name"), k.alias("key")))))
    rows = docs.select("doc_id", F.posexplode(both).alias("__line_at", "__line")).where("__line is not null")
    return rows.select("doc_id", "__line_at", F.col("__line.key").alias("__line_key"), F.col("__line.name").alias("__line_text"))


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`__line_key`, `__line_keeper`: keys in at least `min_docs` documents, and the doc_id that keeps them."""
    return (
        judged_lines(docs, min_chars=min_chars)
        .groupBy("__line_key", "doc_id").agg(F.lit(1).alias("__line_one"))
        .groupBy("__line_key")
        .agg(F.count("doc_id").alias("__line_docs"), F.max("doc_id").alias("__line_keeper"))
        .where(F.col("__line_docs") >= min_docs)
        .select("__line_key", "__line_keeper")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with `__line_kept` (text without the dropped lines), `__line_total` and `__line_dropped`."""
    repeated = materialise(repeated_keys(docs, min_chars, min_docs), "line-keys")
    # rows of one doc_id with one text lose the same lines, so a row is known by both
    lost = (
        judged_lines(docs, named=True, min_chars=min_chars)
        .join(repeated, "__line_key")
        .where(~F.col("doc_id").eqNullSafe(F.col("__line_keeper")))
        .groupBy(F.col("doc_id").alias("__line_doc"), "__line_text")
        .agg(F.collect_set("__line_at").alias("__line_lost"))
    )
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("__line_doc")) & (_text_name(F.col("text")) == F.col("__line_text")), "left")
    # one struct a row: inside lambdas a plain column would be split anew for every line
    left = lambda ls: F.when(F.col("__line_lost").isNull(), ls).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "__line_lost"), lambda i: F.get(ls, i))
    )
    done = let(
        _lines(F.col("text")),
        lambda ls: let(left(ls), lambda kept: F.struct(F.array_join(kept, "\n").alias("kept"), F.size(ls).cast("long").alias("total"), (F.size(ls) - F.size(kept)).cast("long").alias("dropped"))),
    )
    return joined.withColumn("__line_done", done).select(
        *docs.columns, *(F.col(f"__line_done.{c}").alias(f"__line_{c}") for c in ("kept", "total", "dropped"))
    )


def dedup_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with their remaining lines, in the columns of `docs`."""
    new = {"text": F.col("__line_kept"), "n_chars": F.length("__line_kept").cast("long")}
    return dedup_lines(docs, **options).select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("__line_total").alias("n_lines"),
        F.col("__line_dropped").alias("n_dropped"),
        F.sha2("__line_kept", 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
