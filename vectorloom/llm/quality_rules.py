"""Quality rules, line first: each line is judged by punctuation, navigation and boilerplate
rules, failing lines go, and a document that loses too much of its text is rejected.

DataFrame functions only; every document is judged inside its own row, so nothing is
shuffled and a document of any length costs time in proportion to it (n log n where its
windows repeat).

Defined cases: null or blank text has no words and fails the base rules; lines of white
space only are neither judged nor counted, and stay where they are; repeated rows are judged alike; other columns
are carried along, the verdict stands in one struct column `__rules`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, read, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_KEPT_PERCENT = 50
MIN_SENTENCES = 3
# What a sentence may end with, and phrases of notices that are no prose.
LINE_END = r"[.!?…:;,\"'”’»)\]]$"
SENTENCE = r"[.!?…] "
NOTICE = r"(?i)all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|subscribe|newsletter|(sign|log) ?in\b"
NOTICE_MAX_CHARS = 200


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words (a power of two) that occur at least twice in the text."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            repeated = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
            starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
            first = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                starts,
                first,
                lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, count))

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of twice as many words, from two neighbours."""
        return let(hashes, lambda hs: F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + width))))

    windows, width = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while width < window:
        windows, width = doubled(windows, width), 2 * width
    whole = let(windows, lambda hs: F.slice(hs, 1, F.size(hs) - (window - 1)))
    return F.when(F.size(ws) <= window, 0).otherwise(let(whole, covered)).cast("long")


def good_line(line: Column) -> Column:
    """Whether a stripped, non-empty line is prose: it ends as a sentence does or holds several
    sentences, is no list of links, is not littered with marks or shouts, and is no notice."""
    removed = lambda what: F.length(line) - F.length(F.replace(line, F.lit(what), F.lit("")))
    n = F.length(line)
    pipes = removed("|")
    shouts = removed("!!") / 2
    marks = F.regexp_count(line, F.lit(r"[#*$%&<>]"))
    return (
        (line.rlike(LINE_END) | (F.regexp_count(line, F.lit(SENTENCE)) >= MIN_SENTENCES))
        & ~((pipes >= 2) & (pipes * 40 >= n))
        & ~((shouts >= 3) & (shouts * 20 >= n))
        & ~((marks >= 5) & (marks * 10 >= n))
        & ~((n <= NOTICE_MAX_CHARS) & line.rlike(NOTICE))
    )


def rules(text: Column) -> Column:
    """One struct with the counts, the verdict and the remaining text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n", -1)
    strip = lambda x: F.btrim(x, F.lit(SPACES))
    by_word = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
        ),
    )

    def by_line(ls: Column) -> Column:
        return let(
            F.transform(ls, lambda x: F.struct(x.alias("line"), strip(x).alias("ink"))),
            lambda ls: let(
                F.transform(ls, lambda x: F.struct(x["line"].alias("line"), (x["ink"] != "").alias("inked"), ((x["ink"] != "") & good_line(x["ink"])).alias("good"))),
                summed,
            ),
        )

    def summed(marked: Column) -> Column:
        line = lambda x: x["line"]
        inked = F.transform(F.filter(marked, lambda x: x["inked"]), line)
        good = F.transform(F.filter(marked, lambda x: x["good"]), line)
        return let(
            inked,
            lambda it: let(
                good,
                lambda good: F.struct(
                    (F.size(it) - F.size(F.array_distinct(it))).cast("long").alias("n_dup_lines"),
                    F.size(it).cast("long").alias("n_lines"),
                    F.size(good).cast("long").alias("n_good_lines"),
                    F.length(F.array_join(it, "")).cast("long").alias("line_chars"),
                    F.length(F.array_join(good, "")).cast("long").alias("good_chars"),
                    F.array_join(F.transform(F.filter(marked, lambda x: ~x["inked"] | x["good"]), line), "\n").alias("text"),
                ),
            ),
        )

    def verdict(w: Column, x: Column) -> Column:
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"),
            w["word_chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            x["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (100 * x["good_chars"] >= MIN_KEPT_PERCENT * x["line_chars"])).alias("kept"),
            (x["n_lines"] - x["n_good_lines"]).alias("n_removed_lines"),
            x["text"].alias("text"),
        )

    return let(by_word, lambda w: let(let(lines, by_line), lambda x: verdict(w, x)))


def judge(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__rules", rules(F.col("text")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their remaining lines, in the columns of `docs`."""
    text = F.col("__rules.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    judged = judge(docs).where("__rules.kept")
    return judged.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = docs.select("doc_id", rules(F.col("text")).alias("r"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"]
    return judged.select("doc_id", *(F.col(f"r.{n}").alias(n) for n in names))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS key
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), rep AS (
  SELECT w.doc_id, count(DISTINCT w.i + o.j) AS n
  FROM win w JOIN (SELECT doc_id, key FROM win GROUP BY doc_id, key HAVING count(*) >= 2) r
    ON w.doc_id = r.doc_id AND w.key = r.key
  CROSS JOIN (SELECT unnest(range(0, 8)) AS j) o
  GROUP BY w.doc_id
), judged AS (
  SELECT doc_id, ws, lines, text,
    list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x:
      (regexp_matches(x, '[.!?…:;,"''”’»)\]]$') OR len(regexp_extract_all(x, '[.!?…] ')) >= 3)
      AND NOT (length(x) - length(replace(x, '|', '')) >= 2 AND (length(x) - length(replace(x, '|', ''))) * 40 >= length(x))
      AND NOT ((length(x) - length(replace(x, '!!', ''))) / 2 >= 3 AND (length(x) - length(replace(x, '!!', ''))) * 10 >= length(x))
      AND NOT (length(regexp_replace(x, '[^#*$%&<>]', '', 'g')) >= 5 AND length(regexp_replace(x, '[^#*$%&<>]', '', 'g')) * 10 >= length(x))
      AND NOT (length(x) <= 200 AND regexp_matches(x, '(?i)all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|subscribe|newsletter|(sign|log) ?in\b'))
    ) AS good
  FROM d
), counted AS (
  SELECT j.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(lines) - len(good) AS n_removed_lines,
    length(array_to_string(good, '')) AS good_chars, length(array_to_string(lines, '')) AS line_chars
  FROM judged j LEFT JOIN rep ON j.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * good_chars >= 50 * line_chars AS kept,
  n_removed_lines
FROM counted
"""
